"""Mass-mobility analytics on Spark: GPS points to tracks, flows, places, modes and matched roads."""

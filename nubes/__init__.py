"""nubes: point clouds as DataFrames, metrics as aggregations over a distance relation, statistics as grouped SQL."""

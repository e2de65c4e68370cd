"""DataFrame operators on tracks, regions, routes, forecasts and results."""

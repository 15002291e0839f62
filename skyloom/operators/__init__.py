"""DataFrame -> DataFrame operators.  All lazy, all keyed by station, storm or radar."""

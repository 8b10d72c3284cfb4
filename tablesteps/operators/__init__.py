"""DataFrame -> DataFrame operators: table steps, procedures, reconciliation, profiling."""

"""helixloom: DataFrame operators for cohort-scale interval, copy-number and rearrangement data."""

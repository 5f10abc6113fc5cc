"""tabsense — automatic table analysis as Spark DataFrame plans.

Profiles any table (nulls, distinct values, exact quantiles, outliers,
correlations, histograms), infers measure / date / dimension columns,
computes KPIs, trimmed time trends and ranked breakdowns, turns them into
checkable facts and rejects narrative numbers the facts do not support.
Around that: guarded SQL, keyed change application, relationship checks,
query-log retention and ingest cleaning.

Every public function takes and returns DataFrames; the only values that
ever reach the driver are per-column statistics (one row per column) used
to choose which columns to analyse.
"""

__version__ = "0.1.0"

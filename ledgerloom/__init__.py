"""ledgerloom: leave-ledger and page-table analytics as Spark DataFrame jobs."""

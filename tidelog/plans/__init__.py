"""The registered queries: operators applied to the driver's tables, and the SQL that each one equals."""

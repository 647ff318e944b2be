"""Plan shapes shared by operators: tables that cut lineage, and connected components."""

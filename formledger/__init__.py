"""Form-record ETL, supplier ledgers and scores as Spark jobs."""

"""tidegraph: transaction-graph analytics as PySpark DataFrame plans."""

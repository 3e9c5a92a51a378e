"""graphlode: code-graph analytics and corpus preparation on PySpark."""

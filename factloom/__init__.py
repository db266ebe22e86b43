"""factloom: relational and recursive analytics over program facts, on Spark."""

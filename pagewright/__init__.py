"""pagewright: documentation analytics and retrieval as Spark DataFrame plans."""

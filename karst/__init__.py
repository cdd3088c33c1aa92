"""karst: knowledge retrieval and operational analytics as Spark DataFrame operators."""

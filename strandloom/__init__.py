"""strandloom: k-mer graph analytics and sequence encoding as Spark DataFrame jobs."""

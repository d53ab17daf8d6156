"""Reading CSV files into documents, and the partitioned corpus store."""

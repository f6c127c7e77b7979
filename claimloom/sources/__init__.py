"""Reading and writing of tables and graph files."""

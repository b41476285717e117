"""Reading raw pages, feeds and tables, and writing what the pipeline makes."""

"""Document analytics on Spark: files, pages, text runs, images and jobs as DataFrames."""

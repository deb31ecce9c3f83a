"""Document corpus analytics on Spark: tables in, tables out."""

"""File sources and sinks: question folders, background unigrams, word
associations, article XML, web pages, metric files and result files.

Writers group rows into files by a bounded key so no task ever holds a whole
table; readers use Spark's file sources (schema given, corrupt files
tolerated) and never read a file on the driver.
"""

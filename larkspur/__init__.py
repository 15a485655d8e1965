"""larkspur: message, page, URL and call-transcript threat analytics on Spark."""

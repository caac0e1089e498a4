"""Results as tables, CSV, JSON, HTML and CI annotations. Only bounded results come to the driver."""

"""themeflow: follow themes in social and media posts with Spark."""

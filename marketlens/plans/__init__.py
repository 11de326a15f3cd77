"""The data preparation job and one module per report page."""

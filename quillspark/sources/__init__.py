"""Sources and the views that queries read."""

"""Reading physical plans, and session settings sized for a large cluster."""

"""Jobs that follow a changing vault."""

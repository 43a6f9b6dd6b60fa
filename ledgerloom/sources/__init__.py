"""Reading inputs and writing outputs."""

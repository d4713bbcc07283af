"""Column functions and the few special functions that tests need on the driver."""

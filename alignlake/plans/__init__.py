"""Registered queries over the driver's tables, with equivalent SQL."""

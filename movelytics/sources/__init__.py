"""Inputs and outputs: table scans, derived movement and weather views, geometry literals, checked publishing."""

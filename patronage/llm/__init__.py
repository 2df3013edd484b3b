"""Operators that turn raw text tables into training data. Nothing outside this package imports it."""

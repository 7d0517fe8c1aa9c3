"""Operators for preparing training text: quality, copies, mixing, archives."""

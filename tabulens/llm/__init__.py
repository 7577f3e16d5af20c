"""Operators for training data: each module holds one operator, ``queries`` the registered queries and their SQL."""

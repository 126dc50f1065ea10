"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers them for the driver and ``textkernel`` has the vectorised
tokeniser that several of them share.
"""

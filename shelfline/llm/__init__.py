"""Operators for preparing training text: ten independent jobs over documents and pages."""

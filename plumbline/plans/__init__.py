"""Registered queries: one module per operator family, collected by ``registry``."""

"""Readers and the constant price, voucher, language and market tables."""

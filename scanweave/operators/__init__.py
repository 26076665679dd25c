"""Operators on cells, curves, images and tables of scans."""

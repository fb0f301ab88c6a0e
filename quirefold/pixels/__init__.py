"""Pixel kernels on numpy arrays, and the PNG codec that feeds them inside Arrow functions."""

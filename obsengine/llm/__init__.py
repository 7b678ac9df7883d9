"""Operators of a training-data pipeline. Nothing else in obsengine imports this package."""

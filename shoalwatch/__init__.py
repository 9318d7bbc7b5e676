"""Coordinated-activity analytics and training-data operators on Spark."""

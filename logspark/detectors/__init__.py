"""Anomaly detectors on session count vectors and event sequences.

All fit on distributed rows. What reaches the driver has the size of the event vocabulary, of the
model, or of a fixed sample.
"""

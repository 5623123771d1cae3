"""Operators for preparing training data at corpus scale (see README, "Training-data operators")."""

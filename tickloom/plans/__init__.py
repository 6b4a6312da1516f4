"""Logical plans: the event tape and the feature vector."""

"""Stateful and micro-batch operators."""

"""Kept empty: every operator of this engine is a batch job over snapshots.

A new snapshot of a table or catalogue is handled by running the profile and
``operators.store.upsert`` again, so no stateful stream is offered.
"""

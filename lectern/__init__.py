"""Lectern: a PySpark-native engine for analysing long-form, multi-chapter text."""

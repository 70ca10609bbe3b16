"""Declarative, governed exports of related tables on Spark."""

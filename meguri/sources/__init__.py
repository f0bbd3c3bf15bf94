"""Readers and writers: CSV lists, landed JSON and pages, archives."""

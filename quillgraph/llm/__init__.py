"""Operators a training-data pipeline needs beside the graph analytics. Nothing else imports this."""

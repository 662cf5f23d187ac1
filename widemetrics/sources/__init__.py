"""Decoders from landed text and requests to the long datum form."""

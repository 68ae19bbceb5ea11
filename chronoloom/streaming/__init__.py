"""Streams of job events and samples. Windows by event time and watermarks go beyond the batch operators."""

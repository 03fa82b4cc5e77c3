"""The batch load as a stream of arriving files."""

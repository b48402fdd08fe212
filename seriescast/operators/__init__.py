"""DataFrame operators over series frames."""

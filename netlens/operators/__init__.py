"""DataFrame operators over packets and logs."""

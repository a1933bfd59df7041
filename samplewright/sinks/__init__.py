"""Writers that put result tables on shared storage."""

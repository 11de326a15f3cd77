"""Running the plans over the supplied test tables and checking them with SQL."""

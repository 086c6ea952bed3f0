"""The registered queries: operators run on stand-ins for the driver's tables."""

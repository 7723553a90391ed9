"""Where the coverage tables come from: declared schemas, readers, and the fixture derived from the driver tables."""

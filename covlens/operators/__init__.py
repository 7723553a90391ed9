"""The operators: additive requests, shares, hierarchy and drills, rollup, quality checks, preparation jobs, trends."""

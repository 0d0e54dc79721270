"""Time-series cleaning on Spark DataFrames: filters, wavelets, adaptive noise cancelling, cycle stacks, spectra and networks."""

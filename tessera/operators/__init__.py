"""Arrays, margins, products, sweeps, deviances and workflows."""

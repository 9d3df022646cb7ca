"""DataFrame-to-DataFrame operators: cleaning, quality, rollups, questions, insights, claims."""

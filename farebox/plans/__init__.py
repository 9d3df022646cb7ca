"""Multi-step jobs: table choice, publication, extracts and reports."""

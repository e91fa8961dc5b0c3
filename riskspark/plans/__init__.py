"""Multi-operator jobs: training, scoring, explanation."""

"""Multi-job plans: the trainers, the detector and cross-validation."""

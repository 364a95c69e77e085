"""Plan helpers: where lineage is cut and how skewed keys are taken apart."""

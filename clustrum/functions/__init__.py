"""Column builders: metrics, edit distances, energies, deterministic draws."""

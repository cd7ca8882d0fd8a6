"""kernels layer."""

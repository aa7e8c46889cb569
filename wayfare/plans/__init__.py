"""Physical-plan helpers: size-checked broadcasts, staged iterations."""

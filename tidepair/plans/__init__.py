"""Scale-safe plan building blocks shared by the operators."""

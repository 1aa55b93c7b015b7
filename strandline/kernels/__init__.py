"""Small numpy kernels for recursions and small linear algebra; none of them knows Spark."""

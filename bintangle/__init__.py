"""bintangle: contact-map analytics and data preparation as Spark DataFrame jobs."""

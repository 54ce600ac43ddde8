"""tidewright: customer-data onboarding as Spark DataFrame jobs."""

"""gaugewell: learner-response analytics and corpus preparation as Spark DataFrame operators."""

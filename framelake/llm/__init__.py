"""Operations for training-data pipelines, numbered as the queries op1 to op13."""

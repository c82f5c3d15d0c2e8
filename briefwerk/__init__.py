"""Privacy-safe filing analytics for letters, as Spark DataFrame functions.

Every public function takes and returns a DataFrame or a Column; nothing here
pulls rows to the driver.
"""

"""Texts shown to people."""

from __future__ import annotations

# Error messages, then the subjects of a report.
NOT_FOUND = (
    "Error: Dataset not found, check ID again. \n"
    " If the dataset was requested over 4 weeks ago, it has been deleted and must be requested again."
)
DATES_REVERSED = "Error: The end date must be the same as or after the start date"
RANGE_TOO_LONG = "Error: Selected range must be 6 hours or less"
START_INVALID = "Error: Start time is not valid"
END_INVALID = "Error: End time is not valid"

REPORT_READY = "Your report is ready!"
REPORT_EMPTY = "Data request: No data found"

# The sentence of a report after the customer and the days; and why a request of a batch was not taken.
REPORT_FOUND = "the data are available under dataset ID %s."
REPORT_NONE = "no data were found for this period. Data older than 6 months may have been deleted."
REQUEST_REJECTED = "Data request: Not accepted"
NO_DATASET = "Error: The request has no dataset ID"
NO_CUSTOMER = "Error: The request has no customer"
DATES_INVALID = "Error: The request needs two valid dates"
DATASET_REPEATED = "Error: Several requests have this dataset ID"
DATASET_EXISTS = "Error: The dataset ID exists already"

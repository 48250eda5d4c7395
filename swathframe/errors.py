"""Errors of the engine; each has a stable code."""


class SurveyError(Exception):
    code = "internal_error"
    codes: tuple[str, ...] = ()

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        if code is not None and self.codes and code not in self.codes:
            raise ValueError(f"{code} is not a code of {type(self).__name__}")
        self.code = code or (self.codes[-1] if self.codes else type(self).code)


class InputError(SurveyError):
    codes = ("folder_not_found", "file_not_found", "no_images", "too_few_images", "too_few_gps", "no_gps", "image_dir_missing", "empty_file", "invalid_edits", "invalid_argument")


class AlignmentError(SurveyError):
    codes = ("sfm_failed", "georef_too_few", "georef_mismatch")


class ProcessingError(SurveyError):
    codes = ("dsm_failed",)


class ProjectError(SurveyError):
    codes = ("not_aligned", "not_rendered", "not_multispectral")


class Cancelled(SurveyError):
    codes = ("cancelled",)
